"""Near-duplicate texts: SimHash links by anchor points, verified by Jaccard similarity and completed by prefix filtering.

Fingerprints of texts whose word shingles have a Jaccard similarity of 0.8 differ in 10 of 64 bits on average, more than
anchors can cover. So links of close fingerprints (simhash.fingerprint_links, whose groups of copies are the bulk
of all near-duplicates) come first and are verified on all shingles; then come the texts that these leave
apart. A text is the set of its shingles' hashes in an order that all texts share: those found in the fewest texts first.
Two sets of at least a given similarity have a shingle in common among the first few of each (the prefix), so texts
that share one are candidates, and those alone are compared. A text with enough shingles of its own has no other in
its prefix, and so no candidates. First each text is compared with one leader, then with the others that lead a
shingle of its prefix and are not connected to it yet, then with hubs, drawn anew at each turn, that connect most of a group of near
copies of which only every second pair is similar; last with all candidates still apart. Exact bar collisions of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.llm.common import Rows, delete_table, discard, extended, keeping, let_go_of_kept, materialize, release, shuffle_width, without
from slotwise.llm.components import connected_components
from slotwise.llm.simhash import fingerprint, fingerprint_links

SHINGLE, SEED = 5, 42
#: The least similarity as a fraction.
SIMILAR = (4, 5)
#: Shingles that a task adds up at a time, and parts in which they are looked up.
COUNTED, PARTS = 1_000_000, 2
#: Hubs of a shingle, and of a text at a turn. Turns end once the pairs left are at most FEW times the places that they meet in, or fewer than
#: one of USEFUL comparisons connects; what is left open then is compared in full, so neither has a part in the result.
HUBS, FEW, USEFUL = 8, 2, 50


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the text's word shingles; of all words where there are fewer; none without words."""
    words = text.encode().lower().split() if text else []  # of bytes, lower() turns A-Z alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, ends, starts, at = b" ".join(words), [], [0], -1
    for n in map(len, words):
        at += n + 1
        ends.append(at)
        starts.append(at + 1)
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(line[a:b], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :])), dtype=np.uint64))


def is_similar(x: np.ndarray, y: np.ndarray, similar: tuple[int, int] = SIMILAR) -> bool:
    """At least similar[0] / similar[1] of the union are in both; two empty sets are alike."""
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared * similar[1] >= (len(x) + len(y) - shared) * similar[0]


def prefix_length(n: int, similar: tuple[int, int] = SIMILAR) -> int:
    """How many of a set's n shingles are its prefix: one more than a similar set may lack."""
    return n + (-n * similar[0]) // similar[1] + 1 if n else 0


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b: classes) whose sets are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            kept = []
            for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if a != last:
                    last, mine = a, shingle_set(x)
                if is_similar(mine, shingle_set(y)):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64()))], names=["a", "b"])

    with_b = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("y")), "b")
    both = with_b.join(texts.select(F.col("class").alias("a"), F.col("text").alias("x")), "a")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "similar")


def _possible(a: str, b: str) -> str:
    """Condition that the sizes, and what comes after the shared shingle, leave room for the similarity."""
    p, q = SIMILAR
    return f"{q} * least({a}.size, {b}.size) >= {p} * greatest({a}.size, {b}.size) and {p + q} * (1 + least({a}.size - {a}.at, {b}.size - {b}.at)) >= {p} * ({a}.size + {b}.size)"


def rare_prefixes(texts: DataFrame) -> DataFrame:
    """key, class, size, at: those shingles of each text's prefix that other texts have too; at is the place in the order, from 1 on.

    texts: class, text. Shingles are counted over all texts. Those of one text stand first in its order, and are no rows
    here; a window orders the others of a text.
    """

    def keys(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, size = [], 0
            for batch in batches:
                for text in batch.column(0):
                    found = shingle_set(text.as_py())
                    parts.append(found[found % np.uint64(PARTS) == part])
                    size += len(parts[-1])
                    if size >= COUNTED:
                        yield counted(parts)
                        parts, size = [], 0
            if parts:
                yield counted(parts)

        return run

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["key", "n"])

    def places(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = Rows("key", "class", "size")
            for batch in batches:
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = shingle_set(text.as_py())
                    mine = found[found % np.uint64(PARTS) == part].view(np.int64)
                    yield from rows.add(mine, np.full(len(mine), name), np.full(len(mine), len(found), dtype=np.int32))
            yield from rows.drain()

        return run

    # A part of all shingles at a time, so that the disk never holds a shuffle of them all. Tasks add up what COUNTED shingles hold, which
    # is enough for the frequent ones. Most are found once: to aggregate them before the shuffle would fill a task's memory and save
    # nothing, so they are dealt out first.
    shared = None
    for part in range(PARTS):
        counts = texts.select("text").mapInArrow(keys(part), "key long, n long").repartition(shuffle_width(texts.sparkSession), "key").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
        counts = materialize(counts, "shingle-counts")
        release(texts.sparkSession)
        found = materialize(texts.select("class", "text").mapInArrow(places(part), "key long, class long, size int").join(counts, "key"), "shared-places")
        shared = found if shared is None else shared.unionByName(found)
        discard(counts)
    mine = Window.partitionBy("class")
    own = F.col("size") - F.count("*").over(mine)
    placed = shared.withColumn("at", own + F.row_number().over(mine.orderBy("n", "key")))
    most = F.col("size") - F.ceil(F.col("size") * SIMILAR[0] / SIMILAR[1]) + 1
    prefixes = materialize(placed.where(F.col("at") <= most).select("key", "class", "size", F.col("at").cast("int").alias("at")), "prefixes")
    release(texts.sparkSession)
    return prefixes


def _close_fingerprints(texts: DataFrame) -> DataFrame:
    """a, b (classes): candidates whose fingerprints are equal or linked through anchors."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), SHINGLE) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["class", "fp"])

    marked = materialize(texts.select("class", "text").mapInArrow(mark, "class long, fp long"), "similar-prints")
    leads = materialize(marked.groupBy("fp").agg(F.min("class").alias("lead")), "similar-leads", marked.count())
    equal = marked.join(leads, "fp").where("class <> lead").select(F.col("lead").alias("a"), F.col("class").alias("b"))
    links = materialize(fingerprint_links(leads), "similar-anchors")
    named = links.join(leads.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(leads.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")
    return materialize(equal.unionByName(named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct(), "similar-candidates")


def _connected(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after further links; those without any have no row."""
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def _open_places(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """key, class, size, at, root: the places of those shingles whose texts are not all of one root."""
    most = placed.count()
    with keeping(placed.sparkSession, "open"):
        named = roots.select(F.col("node").alias("class"), "root")
        labelled = materialize(placed.join(named, "class", "left").select("key", "class", "size", "at", F.coalesce("root", "class").alias("root")), "labelled", most)
        split = materialize(labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "split-shingles", most)
        return materialize(labelled.join(split, "key", "left_semi"), "open", most)


def _hub_pairs(places: DataFrame, turn: int) -> DataFrame:
    """a, b (classes): each text with HUBS others of its shingles, not connected to it yet.

    All draw a number anew at each turn, and those of the smallest numbers are hubs, so texts of many common shingles have the same. A
    shingle passes on HUBS of its texts only, and a text is compared with HUBS at most: rows grow with the places.
    """
    drawn = places.withColumn("draw", F.xxhash64("class", F.lit(turn)))
    hubs = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("draw", "class"))).where(F.col("_n") <= HUBS).drop("_n")
    met = places.alias("p").join(hubs.alias("h"), F.expr("p.key = h.key and p.root <> h.root and " + _possible("p", "h"))).select(F.col("p.class").alias("class"), F.col("h.class").alias("hub"), "draw").distinct()
    few = met.withColumn("_n", F.row_number().over(Window.partitionBy("class").orderBy("draw", "hub"))).where(F.col("_n") <= HUBS)
    return few.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()


def similar_links(texts: DataFrame) -> DataFrame:
    """a, b (classes) that connect all texts of similar sets. texts: one row for each distinct set, columns class and text.

    What is known of the components goes from step to step as roots, a row a text, so no step walks over all links again.
    """
    spark = texts.sparkSession

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Those of pairs that roots don't connect."""
        a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        return pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")

    with keeping(spark, "similar-candidates"):
        close = _close_fingerprints(texts)
    links = _verified(close, texts)
    release(spark)
    roots = connected_components(links)
    every = rare_prefixes(texts)
    keys = materialize(every.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("class", "size", "at")).alias("l")).where("n > 1").select("key", "l"), "shared-shingles", every.count())
    placed = materialize(every.join(keys, "key"), "shared-prefixes", every.count())
    discard(every)
    led = materialize(placed.alias("p").where("class <> l.class and " + _possible("p", "l")).select(F.col("l.class").alias("a"), F.col("class").alias("b")).distinct(), "led", placed.count())
    first = materialize(apart(led.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), roots), "led-first", led.count())
    roots = _connected(roots, _verified(first, texts))
    release(spark)
    rest = materialize(apart(led.join(first, ["a", "b"], "left_anti"), roots), "led-rest", led.count())
    roots = _connected(roots, _verified(rest, texts))
    release(spark)
    tried, turn, worth = led, 0, True
    placed = placed.drop("l")
    while True:
        left = _open_places(placed, roots)
        pairs, places = left.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside")).agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if pairs <= FEW * places or not worth:
            break
        compared = materialize(_hub_pairs(left, turn).join(tried, ["a", "b"], "left_anti"), "hub-pairs", HUBS * left.count())
        delete_table(left)
        found = _verified(compared, texts)
        asked, told = compared.count(), found.count()
        roots = _connected(roots, found)
        tried = tried.unionByName(compared)
        turn += 1
        release(spark)
        worth = asked > 0 and told * USEFUL >= asked
    pairs = left.alias("p").join(left.alias("q").hint("merge"), F.expr("p.key = q.key and p.class < q.class and p.root <> q.root and " + _possible("p", "q")))
    pairs = materialize(pairs.select(F.col("p.class").alias("a"), F.col("q.class").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "open-pairs")
    return roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_verified(pairs, texts))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of similar texts: that of the smallest id (nulls last), of equal ids the first row.

    Texts of one shingle set, such as exact copies and all texts without words, form a class and are compared once.
    """
    kept = without(docs, ["_class", "_row"])
    at = kept.columns.index(text_col)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go_of_kept()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            names = np.array([xxhash.xxh3_64_intdigest(shingle_set(t.as_py()).tobytes()) for t in batch.column(at)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names), pa.array(range(row, row + len(names)), pa.int64())], names=[*batch.schema.names, "_class", "_row"])
            row += len(names)

    with keeping(docs.sparkSession, "leaders", "keepers"):  # what the result is read from
        marked = materialize(kept.mapInArrow(mark, extended(kept.schema, "_class long, _row long")), "shingled")
        most = marked.count()
        classes = materialize(marked.groupBy("_class").agg(F.min(F.struct(F.col(id_col).isNull(), id_col, "_row")).alias("first")), "classes", most)
        # The first row of each class, whole: what is compared, and all that can stay. The other rows, and a second copy of these, need no room from here on.
        leaders = materialize(marked.join(classes.select(F.col("first._row").alias("_row")).hint("merge"), "_row", "left_semi"), "leaders")
        discard(marked)
        texts = leaders.select(F.col("_class").alias("class"), F.col(text_col).alias("text"))
        roots = connected_components(similar_links(texts))
        rooted = classes.join(roots.withColumnRenamed("node", "_class"), "_class", "left").select("first", F.coalesce("root", "_class").alias("root"))
        keepers = materialize(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row")), "keepers", most)
    return leaders.join(keepers.hint("merge"), "_row", "left_semi").select(*kept.columns)
