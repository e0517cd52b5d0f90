"""Removal of repeated word sequences by recompression.

A document's words are symbols of level 0. Rounds name runs and pairs: first two equal neighbours that
stand alone, then, twice, a left symbol and the right symbol after it, where a symbol's side is a bit of its
name. A name is a hash of what it is made of, so it is the same everywhere without a table of names, and
whether two neighbours merge depends on at most two symbols around them. Hence of two equal stretches of words all symbols
but those near the ends are equal: a symbol spans at most 8 words, and inside a window of 35 words the borders from 8
after its start to 8 before its end are decided by the window alone, which holds at least one whole symbol.

Each window takes the symbol there of most bytes (then of largest name), which has 8 words of the window at least on
either side. Its mark is a hash of that symbol's words and those 16. Equal windows have equal marks,
so a window whose mark is found once is found once. The 16 words are what keeps a phrase that many texts share from
calling for all windows around it. Marks found again reveal repeats; the windows that
carry them are verified by two hashes of all 35 words, together 128 bits: of 10^13 windows, some 10^26
pairs, one in 10^12 tables has a pair of unequal windows that passes. Words enter as 64-bit hashes, of which 10^9 distinct words
have two alike with a chance of 3%.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import Rows, discard, extended, materialize, release, words_of

WINDOW = 35
#: Words at either end of a window whose symbols its surroundings may decide: 2 + 2 + 4 by the rounds' reach.
EDGE = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


#: Rounded down, of the numbers of symbols that a window can hold.
_LOG2 = np.array([max(0, i.bit_length() - 1) for i in range(WINDOW + 1)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _merge(names, starts, first, salt):
    """Symbols where each i of the mask first is merged with i + 1."""
    i = np.flatnonzero(first)
    names, keep = names.copy(), np.ones(len(names), dtype=bool)
    names[i] = _mix(_mix(names[i] + np.uint64(salt)) * _ODD + names[i + 1])
    keep[i + 1] = False
    return names[keep], starts[keep]


def recompress(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names, and numbers of the first words, of the symbols after the rounds."""
    names, starts = hashes, np.arange(len(hashes))
    same = np.concatenate([[False], names[1:] == names[:-1], [False]])
    names, starts = _merge(names, starts, same[1:-1] & ~same[:-2] & ~same[2:], 1)
    for salt in (2, 3):
        right = (_mix(names + np.uint64(salt)) & np.uint64(1)) > 0
        names, starts = _merge(names, starts, ~right[:-1] & right[1:], salt)
    return names, starts


#: A random number for each byte.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
#: Words that are hashed at a time.
_BLOCK = 65_536


def hashed_words(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the bytes of each word: of all words of a block at once, from running sums over its bytes."""
    data = np.frombuffer(text.encode() if text else b"", dtype=np.uint8)
    space = (data == 32) | (data - np.uint8(9) <= 4)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    start, end = edges[::2], edges[1::2]
    hashes = np.zeros(len(start), np.uint64)
    for i in range(0, len(start), _BLOCK):
        a, b = start[i : i + _BLOCK], end[i : i + _BLOCK]
        part, first = data[a[0] : b[-1]], a[0]
        sums = np.concatenate([np.zeros(1, np.uint64), (_BYTE[part] * _powers(_ODD, len(part))).cumsum(dtype=np.uint64)])
        hashes[i : i + _BLOCK] = _mix((sums[b - first] - sums[a - first]) * _powers(_ODD_INVERSE, len(part))[a - first])
    return hashes, end - start


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the power of 0 ... n - 1."""
    out = np.full(n, base)
    out[:1] = 1
    return out.cumprod(dtype=np.uint64)


def window_marks(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window its mark, and around which of the document's symbols that is."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    names, starts = recompress(hashes)
    size = np.add.reduceat(sizes, starts)
    begun = np.zeros(len(hashes) + 1, dtype=np.int64)  # symbols that start before a word
    begun[starts + 1] = 1
    begun = begun.cumsum()
    lo, hi = begun[EDGE : EDGE + n], begun[WINDOW - EDGE + 1 : WINDOW - EDGE + 1 + n] - 1  # whole symbols between the edges
    score = (np.minimum(size, 4095).astype(np.uint64) << np.uint64(52)) | (names >> np.uint64(12))
    tables = [np.arange(len(score))]  # tables[k][s]: the place of the largest, then first, of the 2^k scores from s on
    while 1 << len(tables) <= WINDOW:
        here = tables[-1]
        there = here[np.minimum(np.arange(len(here)) + (1 << (len(tables) - 1)), len(here) - 1)]
        tables.append(np.where(score[there] > score[here], there, here))
    k = _LOG2[hi - lo]
    stack = np.stack(tables)
    a, b = stack[k, lo], stack[k, hi - (1 << k)]
    places = np.where(score[b] > score[a], b, a)
    first, last = np.maximum(starts - EDGE, 0), np.minimum(np.append(starts[1:], len(hashes)) + EDGE, len(hashes))
    return _stretch_hashes(hashes, first, last)[places], places


def _stretch_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the words from each first to before its last, from running sums."""
    sums = np.concatenate([np.zeros(1, np.uint64), (hashes * _powers(_ODD, len(hashes))).cumsum(dtype=np.uint64)])
    return _mix((sums[last] - sums[first]) * _powers(_ODD_INVERSE, len(hashes))[first])


def window_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window two hashes of its words, from running sums; only where windows are verified."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    powers, undo = _powers(_ODD, len(hashes)), _powers(_ODD_INVERSE, n)
    out = []
    for salt in (0, 1):
        sums = np.concatenate([np.zeros(1, np.uint64), (_mix(hashes + np.uint64(salt)) * powers).cumsum(dtype=np.uint64)])
        out.append(_mix((sums[WINDOW:] - sums[:-WINDOW]) * undo))
    return out[0], out[1]


def kept_words(words: list[bytes], starts) -> list[bytes]:
    """words without those that a window at one of starts covers."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.asarray(starts, dtype=np.int64)
    edge[starts] += 1
    np.add.at(edge, starts + WINDOW, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def remove_repeats(docs: DataFrame, with_text: bool = False, text_col: str = "text") -> DataFrame:
    """docs, text replaced by n_words, n_removed, kept_sha256 and, on demand, kept_text (words joined by one space).

    Every word goes that a window of 35 words covers whose words also start anywhere else, in the same document too. A null or
    empty text has no words; texts under 35 words stay whole. Equal texts are one class: of 35 words and
    more they go entirely, and only one of a class sends its windows, counted twice. Columns of docs named
    like a result are replaced. Rows of the window tables grow with the repeated windows, not with their pairs.
    """
    results = ("n_words", "n_removed", "kept_sha256", "kept_text", "_t1", "_t2", "_starts", "_copies")
    taken = {r.lower() for r in results}
    others = [c for c in docs.columns if c != text_col and c.lower() not in taken]
    hashed = docs.select(*others, F.coalesce(text_col, F.lit("")).alias("_text"), F.xxhash64(text_col).alias("_t1"), F.xxhash64(F.lit(1), text_col).alias("_t2"))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Rows("mark", "_t1", "_t2", "at", "size")
        for batch in batches:
            for t1, t2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m, place = window_marks(*hashed_words(text))
                if len(m):  # equal windows, even side by side, have their marks at different places
                    at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                    size = np.diff(np.concatenate([at, [len(m)]]))
                    yield from held.add(m[at].view(np.int64), np.full(len(at), t1), np.full(len(at), t2), at.astype(np.int32), size.astype(np.int32))
        yield from held.drain()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Rows("hash1", "hash2", "_t1", "_t2", "at", "copies")
        for batch in batches:
            for t1, t2, text, copies, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g, h = window_hashes(hashed_words(text)[0])
                at = np.concatenate([np.arange(r["at"], r["at"] + r["size"]) for r in ranges])
                yield from held.add(g[at].view(np.int64), h[at].view(np.int64), np.full(len(at), t1), np.full(len(at), t2), at.astype(np.int32), np.full(len(at), copies))
        yield from held.drain()

    # 1. Where marks stand. Neighbouring windows mostly share one, so that a row stands for several.
    placed = materialize(hashed.select("_t1", "_t2", "_text").mapInArrow(marks, "mark long, _t1 long, _t2 long, at int, size int"), "repeat-marks")
    again = materialize(placed.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"), "repeat-names")
    ranges = placed.join(again, "mark", "left_semi").select("_t1", "_t2", "at", "size").distinct()
    ranges = materialize(ranges.groupBy("_t1", "_t2").agg(F.collect_list(F.struct("at", "size")).alias("ranges")), "repeat-ranges")
    discard(placed)
    # 2. Windows of one text of each class that carry a mark found again, and which of them are. Tasks send one text of
    # a class each, with the number of its copies, so a text with very many copies is no hot key.
    firsts = hashed.select("_t1", "_t2", "_text").where("_text <> ''").groupBy("_t1", "_t2").agg(F.first("_text").alias("_text"), F.count("*").alias("n"))
    single = firsts.join(ranges, ["_t1", "_t2"])
    sent = materialize(single.select("_t1", "_t2", "_text", "n", "ranges").mapInArrow(windows, "hash1 long, hash2 long, _t1 long, _t2 long, at int, copies long"), "repeat-windows")
    discard(ranges)
    repeated = materialize(sent.groupBy("hash1", "hash2").agg(F.sum("copies").alias("n")).where("n > 1").select("hash1", "hash2"), "repeat-found")
    release(docs.sparkSession)
    starts = sent.where("copies = 1").join(repeated, ["hash1", "hash2"], "left_semi").groupBy("_t1", "_t2").agg(F.collect_list("at").alias("_starts"))  # as many as a text has windows
    copied = hashed.groupBy("_t1", "_t2").agg(F.count("*").alias("_copies")).where("_copies > 1").withColumn("_starts", F.lit(None).cast("array<int>"))
    marked = materialize(copied.unionByName(starts.withColumn("_copies", F.lit(1).cast("long"))), "repeat-result")
    discard(sent)

    # 3. Each document by its text's class.
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("_text", "_starts", "_copies")), strict=True)
            out: list[list] = [[], [], [], []]
            for text, at, copies in rows:
                words = words_of(text)
                if copies > 1 and len(words) >= WINDOW:
                    kept = []
                else:
                    kept = kept_words(words, at) if at else words
                joined = b" ".join(kept)
                for column, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None), strict=True):
                    column.append(value)
            arrays = [batch.column(c) for c in others] + [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())] + [pa.array(out[3], pa.string())] * with_text
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    joined = hashed.join(marked, ["_t1", "_t2"], "left").select(*others, "_text", "_starts", F.coalesce("_copies", F.lit(1)).cast("long").alias("_copies"))
    return joined.mapInArrow(strip, extended(docs.select(*others).schema, "n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text))
