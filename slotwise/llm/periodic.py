"""Periodic runs of words: every lag of a text is scanned, and ranges of lags of long texts go to different tasks.

A run with period q is a stretch in which words q apart are equal. So the word ids are compared with themselves shifted by q,
for every q up to a quarter of the text (at an exponent of 4), and long stretches of equal pairs are runs. Lags that can't
hold one are passed over many at a time: (exponent - 1) * q equal pairs in a row, q from Q to 2Q - 1, take in as many
neighbouring multiples of Q, so word jQ is compared with all of the words jQ + Q ... jQ + 2Q - 1 at once, which for all of these lags
is one pass over the text. A stretch that shows at several lags has the least of them as its period: the others are multiples of it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import extended, materialize, shuffle_width, words_of

#: Lags of a text that one task scans; texts of more than four times as many words are dealt out.
LAGS = 4096
EXPONENT, LEAST = 4, 6
_RUN = "start int, period int, length int"


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))


def _possible_lags(ids: np.ndarray, low: int, high: int, exponent: int) -> Iterator[int]:
    """Those of the lags low..high at which exponent - 1 samples in a row agree."""
    n, q = len(ids), 1 << (low.bit_length() - 1)
    while q <= high:
        a, b = max(low, q), min(high, 2 * q - 1)
        rows = -(-n // q)
        there = np.full(rows * q, -1, dtype=np.int32)
        there[: n - q] = ids[q:]
        equal = there.reshape(rows, q)[:, a - q : b - q + 1] == ids[::q, None]
        hits = equal[: max(0, rows - exponent + 2)]
        for k in range(1, exponent - 1):
            hits = hits & equal[k : k + len(hits)]
        yield from (np.flatnonzero(hits.any(axis=0)) + a).tolist()
        q *= 2


def runs_at_lags(ids: np.ndarray, low: int, high: int, exponent: int = EXPONENT, least: int = LEAST) -> dict[tuple[int, int], int]:
    """(start, length) of the maximal stretches with one of the periods low..high, and the least of these periods."""
    found: dict[tuple[int, int], int] = {}
    for q in _possible_lags(ids, low, min(high, len(ids) // exponent), exponent):
        same = np.zeros(len(ids) - q + 2, dtype=np.int8)
        same[1:-1] = ids[q:] == ids[:-q]
        ends = np.flatnonzero(np.diff(same)).reshape(-1, 2)
        for start, end in ends[np.diff(ends)[:, 0] >= max(least - q, (exponent - 1) * q)].tolist():
            found.setdefault((start, end - start + q), q)
    return found


def collapsed(words: list[bytes], runs) -> list[bytes]:
    """words without those that a run contains after its first period. runs: (start, period, length)."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, period, length in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, gone in zip(words, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not gone] if runs else words


def find_runs(docs: DataFrame, with_text: bool = False, text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST, lags: int = LAGS) -> DataFrame:
    """docs, text replaced by n_words, runs (array of start, period, length, in this order), collapsed_sha256 and, on demand,
    collapsed_text: the words that no run contains after its first period, joined by one space.

    A run is a stretch of words with smallest period q and a length of least and exponent * q at least that no neighbouring word
    extends; starts are word numbers from 0. exponent: 2 at least. A null, empty or blank text has no words and no runs; equal rows
    have equal results; texts are taken whole, however long. Columns of docs named like a result are replaced.
    """
    if exponent < 2:
        raise ValueError("a run holds its period twice at least")
    results = ("n_words", "runs", "collapsed_sha256", "collapsed_text", "_row", "_open")
    others = [c for c in docs.columns if c != text_col and c.lower() not in results]
    extra = f"n_words long, runs array<struct<{_RUN.replace(' int', ':int')}>>, collapsed_sha256 string" + ", collapsed_text string" * with_text
    kept = docs.select(*others, F.col(text_col).alias("_open"))
    schema = extended(kept.select(*others).schema, f"{extra}, _row long, _open string")

    def results_of(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
        joined = b" ".join(collapsed(words, runs))
        return (len(words), [dict(zip(("start", "period", "length"), r, strict=True)) for r in runs], hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None)

    def arrays(rows: list[tuple], batch: pa.RecordBatch) -> list[pa.Array]:
        fields = schema.names[len(others) : -2]
        types = [pa.int64(), pa.list_(pa.struct([(f, pa.int32()) for f in ("start", "period", "length")])), pa.string(), pa.string()]
        return [batch.column(c) for c in others] + [pa.array([r[i] for r in rows], types[i]) for i in range(len(fields))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, left = [], []
            for text in batch.column("_open").to_pylist():
                words = words_of(text)
                long = len(words) // exponent > lags
                runs = [] if long else sorted((s, q, m) for (s, m), q in runs_at_lags(word_ids(words), 1, lags, exponent, least).items())
                rows.append((len(words), None, None, None) if long else results_of(words, runs))
                left.append(text if long else None)
            names = pa.array(range(row, row + len(rows)), pa.int64())
            yield pa.RecordBatch.from_arrays([*arrays(rows, batch), names, pa.array(left, pa.string())], names=schema.names)
            row += len(rows)

    def scan_lags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = runs_at_lags(word_ids(words_of(text)), part * lags + 1, (part + 1) * lags, exponent, least)
                if found:
                    starts, lengths = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array(starts, pa.int32()), pa.array(list(found.values()), pa.int32()), pa.array(lengths, pa.int32())], names=["_row", "start", "period", "length"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column("_open").to_pylist(), batch.column("_found").to_pylist()
            rows = [results_of(words_of(t), [tuple(r.values()) for r in found or []]) for t, found in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays(rows, batch), names=schema.names[:-2])

    first = materialize(kept.mapInArrow(scan, schema), "runs")
    open_ = first.where("_open is not null")
    parts = F.explode(F.sequence(F.lit(0), ((F.floor(F.col("n_words") / exponent) - 1) / lags).cast("int"))).alias("part")
    dealt = open_.select("_row", parts, "_open").repartition(shuffle_width(docs.sparkSession), "_row", "part")
    stretches = dealt.mapInArrow(scan_lags, f"_row long, {_RUN}").groupBy("_row", "start", "length").agg(F.min("period").alias("period"))
    merged = stretches.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("_found"))  # as many as a text has
    rest = open_.select(*others, "_row", "_open").join(merged, "_row", "left").select(*others, "_open", "_found")
    closed = first.where("_open is null").select(*schema.names[:-2])
    return closed.unionByName(rest.mapInArrow(finish, extended(kept.select(*others).schema, extra)))
