"""The pipeline's near-dedup stage against all pairs."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
from slotwise.llm import common, jaccard, simhash
from slotwise.llm.components import connected_components


def plain(texts, n=5):
    """Indices that stay: the first of each component over pairs of Jaccard 0.8 or more."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    low = list(range(len(texts)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return [i for i in range(len(texts)) if root(i) == i]


def near_texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "one", "One", "a b c d e", "a b c d f"]
    line = " ".join(rng.choices(words, k=12))
    for n in (6, 20, 80, 250):
        for _ in range(6):
            base = rng.choices(words, k=n)
            texts.append(" ".join(base))
            for changes in (1, 2, 3, 4, 5):
                copy = list(base)
                for _ in range(max(1, changes * n // 100)):
                    copy[rng.randrange(n)] = "new" + str(rng.randrange(99))
                texts.append(" ".join(copy))
            texts.append(" ".join(base[: n * 5 // 6]))
            texts.append(f"{line} {' '.join(rng.choices(words, k=rng.randrange(1, 9)))}")
    return texts


def test_near_dedup_keeps_one_of_each_component_of_similar_texts(spark):
    texts = near_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == plain(texts) and len(got) < len(texts)
    # The fingerprints' rule of 4 bits links other pairs.
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) != got
    assert corpus_pipeline.near_dedup(spark, docs.where("false"), "").count() == 0


def test_similar_sets_share_a_prefix(spark):
    texts = [t for t in near_texts() if t and t.strip()]
    texts = list({jaccard.shingle_set(t).tobytes(): t for t in texts}.values())
    sets = [jaccard.shingle_set(t) for t in texts]
    counts = Counter(k for s in sets for k in s.tolist())
    want = set()
    for i, s in enumerate(sets):
        signed = s.view(np.int64).tolist()
        order = sorted(signed, key=lambda k: (counts[k % 2**64], k))
        want |= {(k, i, len(s), at) for at, k in enumerate(order[: jaccard.prefix_length(len(s))], 1) if counts[k % 2**64] > 1}
    got = jaccard.rare_prefixes(spark.createDataFrame(list(enumerate(texts)), "class long, text string").repartition(3)).collect()
    assert {(r["key"], r["class"], r["size"], r["at"]) for r in got} == want and len(got) == len(want)
    firsts = [{k for k, i, *_ in want if i == j} for j in range(len(sets))]
    for i in range(len(sets)):
        for j in range(i):
            assert not jaccard.is_similar(sets[i], sets[j]) or firsts[i] & firsts[j]


def test_near_dedup_holds_one_copy_of_each_text(spark, monkeypatch):
    """While pairs are looked for, the disk holds the first row of each distinct set and no other copy of the texts."""
    texts, seen, links = near_texts() * 3, [], jaccard.similar_links
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    with common.scratch(spark) as folder:

        def watched(given):
            for path in Path(folder.removeprefix("file:")).iterdir():
                table = spark.read.parquet(str(path))
                if "text" in table.columns:
                    seen.append(table.count())
            return links(given)

        monkeypatch.setattr(jaccard, "similar_links", watched)
        got = sorted(r.doc_id for r in jaccard.deduplicate(docs).collect())
    assert got == plain(texts)
    assert seen == [len({jaccard.shingle_set(t).tobytes() for t in texts})]


def test_components_in_few_files(spark):
    """However many partitions a shuffle has, small tables are few files, and only the result is left; a chain, loops, repeated edges, and stars as they are."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    chain = [(i, i + 1) for i in range(60)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for edges, want in (
            (chain + chain[:5] + [(7, 7), (100, 90), (101, 90), (300, 200), (300, 201)], {**{i: 0 for i in range(61)}, **{i: 90 for i in (90, 100, 101)}, **{i: 200 for i in (200, 201, 300)}}),
            ([(5, 1), (1, 9), (8, 7)], {1: 1, 5: 1, 9: 1, 7: 7, 8: 7}),
            ([(3, 3)], {}),
        ):
            with common.scratch(spark) as folder:
                found = connected_components(spark.createDataFrame(edges, "a long, b long"))
                assert sorted(map(tuple, found.collect())) == sorted(want.items())
                (left,) = Path(folder.removeprefix("file:")).iterdir()
                assert left.name.startswith("cc-roots") and len(list(left.glob("*.parquet"))) <= 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
