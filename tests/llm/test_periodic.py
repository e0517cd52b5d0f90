"""Periodic runs against a version that tries every start and period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from slotwise.llm import periodic, queries, sql
from tests.llm.test_queries import DOCUMENTS, write


def plain_runs(words, exponent=4, least=6):
    """Maximal stretches by definition: no smaller period, no neighbour that goes on."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q] or (i and words[i - 1] == words[i + q - 1]):
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, exponent * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, q, length))
            i = j + 1
    return sorted(found)


def plain_collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, q, n in runs)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=6), st.integers(2, 4))
def test_every_lag(parts, exponent):
    words = [str(w).encode() for part, times in parts for w in part * times]
    got = periodic.runs_at_lags(periodic.word_ids(words), 1, 10**6, exponent, 6)
    assert sorted((s, q, n) for (s, n), q in got.items()) == plain_runs(words, exponent)
    split = {}
    for low in range(1, len(words) // exponent + 1, 3):  # in ranges of lags, as tasks do
        for key, q in periodic.runs_at_lags(periodic.word_ids(words), low, low + 2, exponent, 6).items():
            split[key] = min(q, split.get(key, q))
    assert split == got


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    out = [None, "", " \n\t ", "one", "a " * 5, "a " * 6, "a b " * 4, "x " + "a b c " * 9 + "a y", "na " * 700, "a a a a a a b " * 12]
    for _ in range(30):
        base = rng.choices(words, k=rng.randint(1, 80))
        at, p = rng.randrange(len(base)), rng.randint(1, 9)
        out.append(" ".join([*base[:at], *(base[at : at + p] * rng.randint(1, 12)), *base[at:]]))
    return [*out, out[-1], out[-1]]


def check(rows, words_by_row, with_text):
    assert len(rows) == len(words_by_row)
    for r in rows:
        words = words_by_row[r.key]
        runs = plain_runs(words)
        joined = " ".join(plain_collapsed(words, runs))
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed_sha256) == (len(words), runs, hashlib.sha256(joined.encode()).hexdigest()), words
        assert not with_text or r.collapsed_text == joined


def test_texts_whole_and_dealt_out(spark):
    """The same whether a text is scanned in one task or its ranges of lags in several; clashing names are replaced."""
    rows = [(i, t, "x", 7, "y") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "key long, text string, Runs string, n_words long, _row string").repartition(3)
    words = {i: (t or "").split() for i, t, *_ in rows}
    for lags in (4096, 5, 1):
        got = periodic.find_runs(docs, with_text=True, lags=lags)
        assert sorted(got.columns) == ["collapsed_sha256", "collapsed_text", "key", "n_words", "runs"]
        check(got.collect(), words, True)
    assert periodic.find_runs(docs.where("false")).collect() == []


def test_very_long_text(spark):
    """70,000 words with a period of 1,500, and one whose every lag agrees: each in several ranges of lags."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(40_000)]
    text = " ".join([*base[:3000], *(base[3000:4500] * 40), *base[4500:11_500]])
    got = {r.key: r for r in periodic.find_runs(spark.createDataFrame([(1, text), (2, "na " * 50_000)], "key long, text string")).collect()}
    assert [tuple(r) for r in got[2].runs] == [(0, 1, 50_000)] and got[2].collapsed_sha256 == hashlib.sha256(b"na").hexdigest()
    (start, period, length), = [tuple(r) for r in got[1].runs if r.period > 100]
    assert period == 1500 and start <= 3000 and start + length >= 63_000 and got[1].n_words == 70_000


def test_op12(spark, tmp_path):
    made = [t for t in texts() for _ in range(2)] + ["p q r s " * 30, "größe x\x0by z " * 20, *[" ".join(f"v{i % 37}" for i in range(n)) for n in range(3, 60, 4)]]
    n = len(made)
    ids = [i * 3 - 20 if i != 5 else None for i in range(n)]
    write(tmp_path, "documents", [ids, made, ["en"] * n, ["s"] * n, [0] * n], DOCUMENTS)
    rows = queries.QUERIES["op12_periods"](spark, str(tmp_path)).collect()
    want, planted = [], 0
    for i, text in zip(ids, made, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        m, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and m:
            a = g % m
            p = 1 + (m - a) // (3 + g % 8)
            words, planted = [words[j] if j < a else words[a + (j - a) % p] for j in range(m)], planted + 1
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[2], r[0], r[1])) if runs else None
        lines = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
        longest = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        want.append((i, len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(plain_collapsed(words, runs)).encode()).hexdigest()))
    assert planted > 3 and sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert sorted(map(str, want)) == sorted(map(str, c.execute(sql.ORACLE["op12_periods"]).fetchall()))


def test_samples_agree_where_a_run_is():
    """No lag that holds a run is passed over, on random ids with few values."""
    rng = np.random.default_rng(1)
    for n in (1, 5, 24, 100, 333):
        ids = rng.integers(0, 2, n).astype(np.int32)
        got = periodic.runs_at_lags(ids, 1, n)
        assert sorted((s, q, m) for (s, m), q in got.items()) == plain_runs(ids.tolist())
