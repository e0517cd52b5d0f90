"""SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into three blocks. Of two fingerprints that differ in at most 4 bits, one
block differs in at most one bit. In each block the words of a covering code are the anchors: two blocks
of 23 bits with the perfect binary Golay code (every word within 3 of exactly one anchor), one of 18
with the perfect Hamming code of length 15 (radius 1) and three bits taken as they are. A fingerprint
goes to every anchor within covering radius plus one. If x and y differ by at most one bit in a block, y
is there at the anchor nearest to x, so each link shows at an anchor; within an anchor's group,
fingerprints are compared with those at home there, on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.common import extended, materialize, shuffle_width, without
from slotwise.llm.components import connected_components

SHINGLE, SEED, THRESHOLD = 4, 42, 4
#: (shift, bits) of the blocks.
BLOCKS = ((0, 23), (23, 23), (46, 18))
#: Anchors of all blocks: codewords, in the last one times its three free bits.
ANCHORS = 2 * (1 << 12) + (1 << 11) * (1 << 3)
#: Fingerprints of an anchor's group that one task compares with the whole group; larger groups are dealt in tiles.
TILE = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit by bit the majority (over half) of the XXH64 of the text's word shingles; no words: 0."""
    words = text.encode().lower().split() if text else []  # of bytes, lower() turns A-Z alone
    if not words:
        return 0
    line, ends, starts = b" ".join(words), [], [0]
    at = -1
    for n in map(len, words):
        at += n + 1
        ends.append(at)
        starts.append(at + 1)
    n = max(1, len(words) - shingle + 1)
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(line[a:b], seed) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :])), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * ones[i] > n))


@cache
def _golay() -> np.ndarray:
    """Codewords of the cyclic code that g(x) = x^11+x^10+x^6+x^5+x^4+x^2+1 spans: the perfect Golay code."""
    words = np.zeros(1, dtype=np.uint32)
    for i in range(12):
        words = np.concatenate([words, words ^ np.uint32(0b110001110101 << i)])
    return np.sort(words)


@cache
def _nearest_golay() -> np.ndarray:
    """The one codeword within 3 bits of each of the 2^23 words."""
    near = np.zeros(1 << 23, dtype=np.uint32)
    code = _golay()
    for k in range(4):
        for bits in combinations(range(23), k):
            near[code ^ np.uint32(sum(1 << b for b in bits))] = code
    return near


@cache
def _golay_weights() -> np.ndarray:
    code = _golay()
    return code[np.bitwise_count(code) <= 7]


def _golay_anchors(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for the anchors within 4 bits: the nearest, a, and those a ^ c, c a codeword of weight 7, where the rest is."""
    home = _nearest_golay()[block]
    rows, anchors = [np.arange(len(block))], [home]
    for c in _golay_weights():
        if c:
            other = home ^ c
            hit = np.flatnonzero(np.bitwise_count(other ^ block) <= 4)
            rows.append(hit)
            anchors.append(other[hit])
    return np.concatenate(rows), np.concatenate(anchors)


def _hamming_home(low: np.ndarray) -> np.ndarray:
    """The codeword within one bit of each 15-bit word: the syndrome is the XOR of the numbers of its set bits."""
    syndrome = np.zeros(len(low), dtype=np.uint32)
    for i in range(15):
        syndrome ^= ((low >> np.uint32(i)) & np.uint32(1)) * np.uint32(i + 1)
    return np.where(syndrome > 0, low ^ (np.uint32(1) << (np.maximum(syndrome, 1) - np.uint32(1))), low)


def _hamming_anchors(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for the anchors within 2 bits, where the code is Hamming(15) and three free bits: at home of the word and of each word one bit away."""
    rows, anchors = [], []
    for flip in [0, *(1 << i for i in range(18))]:
        x = block ^ np.uint32(flip)
        anchors.append(_hamming_home(x & np.uint32(0x7FFF)) | (x & np.uint32(0x38000)))
        rows.append(np.arange(len(block)))
    pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(anchors)]), axis=1)
    return pairs[0], pairs[1].astype(np.uint32)


def anchors_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, home): for each fingerprint its anchors; home where the anchor is the nearest in its block."""
    out = []
    for number, (shift, bits) in enumerate(BLOCKS):
        block = ((fingerprints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.uint32)
        if bits == 23:
            rows, anchors = _golay_anchors(block)
            home = anchors == _nearest_golay()[block][rows]
        else:
            rows, anchors = _hamming_anchors(block)
            home = anchors == (_hamming_home(block & np.uint32(0x7FFF)) | (block & np.uint32(0x38000)))[rows]
        out.append((rows, (number << 24) + anchors.astype(np.int64), home))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def group_links(own: np.ndarray, every: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, a fingerprint of its component) that connect what pairs (x of own, y of every) within threshold connect.

    Rows of x against all y, a block at a time. Each row takes the smallest label among what it links to, each y the
    smallest of its rows; labels that meet are joined, until a block changes nothing. So Python
    walks over labels that differ, never over pairs.
    """
    nodes, at = np.unique(np.concatenate([own, every]), return_inverse=True)
    x_at, y_at = at[: len(own)], at[len(own) :]
    n = len(nodes)
    label = np.arange(n)
    step = max(1, 1_000_000 // max(1, len(every)))
    for i in range(0, len(own), step):
        near = np.bitwise_count(own[i : i + step, None] ^ every[None, :]) <= threshold
        rows = x_at[i : i + step]
        while True:
            low = np.minimum(np.where(near, label[y_at], n).min(axis=1, initial=n), label[rows])
            meets = np.where(near, low[:, None], n).min(axis=0, initial=n)
            pairs = np.unique(np.stack([np.concatenate([label[y_at][meets < n], label[rows]]), np.concatenate([meets[meets < n], low])]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            if not pairs.shape[1]:
                break
            parent = np.arange(n)
            for a, b in pairs.T.tolist():
                p, q = _root(parent, a), _root(parent, b)
                parent[max(p, q)] = min(p, q)
            new = np.arange(n)
            for a in np.unique(pairs).tolist():
                new[a] = _root(parent, a)
            label = new[label]
    moved = np.flatnonzero(label != np.arange(n))
    return nodes[moved], nodes[label[moved]]


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """a, b (fingerprints as signed longs) that connect all distinct fingerprints within the threshold.

    prints: one row per distinct fingerprint, column fp. Keys with more than TILE fingerprints are dealt in
    tiles: a fingerprint at home goes to one tile, by its hash, and every one of the group is copied to all
    tiles, so that each pair with one at home is still compared once.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(fp), 4096):
                part = fp[i : i + 4096]
                rows, key, home = anchors_of(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[rows]), pa.array(home)], names=["key", "fp", "home"])

    def compare(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        mine = table.column("mine").to_numpy(zero_copy_only=False).astype(bool)
        a, b = group_links(fp[home & mine], fp)
        return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

    placed = materialize(prints.select("fp").repartition(shuffle_width(prints.sparkSession), "fp").mapInArrow(spread, "key long, fp long, home boolean"), "anchors")
    large = materialize(placed.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes")).where(f"n > {TILE} and homes > 0").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")), "hot-anchors", ANCHORS)
    tiled = placed.join(large, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("key", "tile", "fp", "home", (F.pmod(F.xxhash64("fp"), F.col("tiles")) == F.col("tile")).alias("mine"))
    return tiled.groupBy("key", "tile").applyInArrow(compare, "a long, b long")


def _roots(classes: DataFrame, most: int) -> DataFrame:
    """fp, first, root: classes (fp, first; most of them at most) with each fingerprint's component, named by its smallest fingerprint."""
    roots = connected_components(materialize(fingerprint_links(classes), "links"))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return materialize(rooted, "rooted", most)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id reachable over links of fingerprints.

    Texts without words (null, empty, blank) all have fingerprint 0 and link like any other. Exact
    copies share a fingerprint, so only distinct ones are compared and copies cost one row each. Rows
    of null doc_id take part and get their component's id. Other columns are ignored. An empty table stays empty.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marked = materialize(keyed.mapInArrow(mark, "doc_id long, fp long"), "fingerprints")
    most = marked.count()
    rooted = _roots(materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes", most), most)
    lowest = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "lowest", most)
    named = materialize(rooted.join(lowest, "root").select("fp", "component_id"), "named", most)
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of near-duplicates: that of the smallest id (nulls last), of equal ids the first row."""
    kept = without(docs, ["_fp", "_row"])
    at = kept.columns.index(text_col)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps), pa.array(range(row, row + len(fps)), pa.int64())], names=[*batch.schema.names, "_fp", "_row"])
            row += len(fps)

    marked = materialize(kept.mapInArrow(mark, extended(kept.schema, "_fp long, _row long")), "fingerprints")
    most = marked.count()
    rooted = _roots(materialize(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min(F.struct(F.col(id_col).isNull(), id_col, "_row")).alias("first")), "classes", most), most)
    keepers = materialize(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row")), "keepers", most)
    return marked.join(keepers.hint("merge"), "_row", "left_semi").select(*kept.columns)
