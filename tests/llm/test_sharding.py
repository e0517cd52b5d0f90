"""Curve order and shards against a plain version; what the files' statistics let a reader skip."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from slotwise.llm import queries, sharding
from slotwise.llm.ann import hilbert_keys
from tests.llm.test_queries import DOCUMENTS, write

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Size string, _key long"


def rows_of(n=400):
    rng = random.Random(9)
    made = [(i if i % 50 else None, "x " * int(rng.paretovariate(0.8)), rng.choice(["de", "en", "en", None]), rng.choice(["hot", "hot", *[f"s{k}" for k in range(9)], None]), rng.choice([None, *range(200)]), "z", 5) for i in range(n)]
    made += [(7, "copy ü", "en", "hot", 6, "z", 5)] * (n // 2)  # a third are one row
    return [*made, (n + 1, None, None, None, None, None, None), (n + 2, "", "en", "hot", 0, "z", 5), (n + 3, "long " * 40_000, "en", "hot", 200_000, "z", 5)]


def plain_cells(values, cells):
    known = sorted(v for v in values if v is not None)
    counts, before, firsts = Counter(known), 0, {}
    for v in sorted(counts):
        firsts.setdefault(before * cells // len(known), v)
        before += counts[v]
    borders = [v for c, v in sorted(firsts.items()) if c]
    return [0 if v is None else 1 + bisect_right(borders, v) for v in values]


def plain(rows, dims, shards, law):
    """(doc_id, size, crc, shard, slot) of each row."""
    cells = np.column_stack([plain_cells([r[d] for r in rows], 31) for d in dims])
    items = []
    for r, key in zip(rows, hilbert_keys(cells, 5).tolist(), strict=True):
        data = (r[1] or "").encode()
        items.append((key, r[0] is not None, r[0] or 0, zlib.crc32(data), len(data) + 1))
    items.sort()
    out, total, before, slots = [], sum(i[4] for i in items), 0, Counter()
    for place, (_, known, i, crc, size) in enumerate(items):
        shard = place * shards // len(items) if law == "rows" else (2 * before + size) * shards // (2 * total)
        out.append((i if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


@pytest.mark.parametrize("law", sharding.LAWS)
def test_against_a_plain_version(spark, law):
    rows = rows_of()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for dims, shards in ((("source", "lang", "n_chars"), 16), (("n_chars", "doc_id"), 5)):
        names = ["doc_id", "text", "lang", "source", "n_chars"]
        got = sharding.order_by_curve(docs, dims, shards, law).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
        assert Counter(map(tuple, got)) == Counter(plain(rows, [names.index(d) for d in dims], shards, law))
    assert sharding.order_by_curve(docs.where("false"), law=law).collect() == []


def test_curve_takes_unit_steps_through_every_cell():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_files_can_be_skipped_by_any_dimension(spark, tmp_path):
    """A filter on either of two independent columns skips most shards; sorting by one column would do so for that one alone."""
    rng = random.Random(2)
    rows = [(i, f"t{i}", "en", f"s{rng.randrange(100):02}", rng.randrange(1000), "z", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "out")
    sharding.write_shards(docs, path, ("source", "n_chars"), 16, rows_a_file=100)
    back = spark.read.parquet(path)
    assert Counter(tuple(r) for r in back.select("doc_id", "text", "source", "n_chars").collect()) == Counter((r[0], r[1], r[3], r[4]) for r in rows)
    zones = sharding.zone_map(back, ("source", "n_chars")).collect()
    assert len(zones) == 16 and {z.n_rows for z in zones} == {250}
    for low in (100, 450, 800):
        assert sum(z.min_n_chars <= low + 50 and z.max_n_chars >= low for z in zones) <= 8
        name = f"s{low // 10:02}"
        assert sum(z.min_source <= name <= z.max_source for z in zones) <= 8
    slots = defaultdict(list)
    for file in (tmp_path / "out").rglob("*.parquet"):
        t = pq.read_table(file)
        assert t.num_rows <= 100
        slots[file.parent.name] += [(file.name, s) for s in t.column("slot").to_pylist()]
    for named in slots.values():
        assert [s for _, s in sorted(named, key=lambda x: x[0])] == list(range(250))  # files in order of name hold the curve's order


def test_op11(spark, tmp_path):
    rows = rows_of(150)
    write(tmp_path, "documents", [[r[k] for r in rows] for k in range(5)], DOCUMENTS)
    got = queries.QUERIES["op11_sharding"](spark, str(tmp_path)).collect()
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == Counter(plain(rows, (3, 2, 4), 16, "rows"))
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
